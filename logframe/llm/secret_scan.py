"""Secret scans: candidates in texts, sifted by a random forest.

Candidates are assigned values (``name = "value"``, ``name: value``) of any length and any
characters, to the closing quote or up to white space or a delimiter before the next
assignment; passwords in addresses; what follows
``Bearer``; private key blocks; tokens of parts joined by dots; and runs of at least
``SHORTEST`` token characters with a digit. Assignments inside values are candidates, too.

A random forest removes false positives by the candidate's length and character classes,
its character transitions under a model of the corpus's own words, its coverage by the
corpus dictionary, its path, and the words next to it. It is trained on labelled findings:
a table (doc_id, begin, label), or, where none is given, secrets and look-alikes planted
into corpus texts and labelled by what was planted (``logframe.llm.planted``). A fifth of
the planted findings is never trained on; ``held_out_quality`` measures the forest on it.

The dictionary and the transitions come from word counts over the whole corpus: the words
that a ``SHARE`` of all documents hold, and the letter pairs of every word. Findings are
planted into at most ``HOSTS`` documents, those with the smallest hash. Words are of Latin
letters: for other scripts the dictionary is empty. Texts may have any length and any runs:
the candidates of a text are a few times as long as it, and each is read once. Of a given table at
most ``FINDINGS`` distinct findings are trained on, half of each class. Whole texts are
scanned. Null and empty texts have no candidates. Offsets count code points. Repeated rows
give repeated results. A table without findings is left as it is, an empty one stays empty.
Where a given table has findings of one class only, that class decides. Extra columns of
any name are kept by ``redact`` and ignored by ``scan``; the path column may be absent.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import durable, release
from logframe.llm.planted import plant

SHORTEST = 16
#: Share of the documents that hold a dictionary word, and the bound on the training findings.
SHARE, FINDINGS = 0.001, 20_000
#: Bound on the documents that findings are planted into, and how many findings there are at least.
HOSTS, PLANTED = 5_000, 4_000
#: One in so many planted findings is held out.
HOLD_OUT = 5
TREES, DEPTH = 32, 10
PLACEHOLDER = "[SECRET]"
CANDIDATE = re.compile(r"[A-Za-z0-9_\-+/]{%d,}={0,2}" % SHORTEST)
SEPARATOR = re.compile(r"[:=][=>]?\s{0,8}")
NAME = re.compile(r"""([A-Za-z][\w\-]*)["'`]?\s*$""")
VALUE = re.compile(r""""(?P<a>(?:\\.|[^"\\\n])++)"|'(?P<b>(?:\\.|[^'\\\n])++)'|`(?P<c>[^`\n]++)`|["'`]?(?P<d>[^\s"'`])""")
#: Where an assignment inside an unspaced run begins: its name, and whether a delimiter stands before it.
WITHIN = re.compile(r"""(?P<cut>[,;&|)}\]]["'`]?)?(?<![\w\-])[A-Za-z][\w\-]*+["'`]?[:=]""")
SPACE = re.compile(r"\s")
ASSIGNED = re.compile(r"""([A-Za-z][\w\-]*)["'`]?\s*[:=][=>]?\s*["'`]?$""")
USER = re.compile(r"://[^\s/]*$")
#: Passwords in addresses, bearer tokens and dotted tokens.
FORMS = re.compile(
    r"://[^\s/:@]++:(?P<b>[^\s/@]++)@|(?i:\bbearer)[ \t]{1,4}(?P<c>[^\s\"',;]{8,})|(?<![\w\-])(?P<d>[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,})*)(?![\w\-])"
)
#: The first and last lines of private key blocks; lines that may follow a first line whose last one is missing.
KEY_LINE = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,64}PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"(?:[ \t]*+(?:[A-Za-z0-9+/=]++|[A-Za-z][A-Za-z\-]*+:[^\n]*+)?[ \t\r]*+(?:\n|\Z))*+")
# fixed values: words of secret and of harmless names, known key beginnings, path words
SECRET_NAMES = re.compile(r"(?i)token|secret|passw|pwd|api_?key|access_?key|private_?key|credential|bearer|auth(?!or(?:s|ed|it\w*)?\b)")
HARMLESS_NAMES = re.compile(r"(?i)^(sha\d*|md5|hash|checksum|digest|commit|rev|revision|uuid|guid|id|etag|integrity|version|example)$")
PREFIXES = re.compile(r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|-----BEGIN)")
TEST_PATHS = re.compile(r"(?i)test|example|sample|mock|fixture|lock|vendor|docs?/")
# end of fixed values
FEATURES = (
    "length", "digits", "upper", "lower", "other", "distinct", "hexadecimal", "entropy", "transition",
    "coverage", "prefix", "assigned", "secret_name", "harmless_name", "quoted", "near_secret", "near_harmless", "test_path", "in_address", "runs",
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WINDOW = 48
RUN = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")


@dataclass(frozen=True)
class Language:
    """What the corpus's words look like: its common words, and log probabilities of letter pairs."""

    words: frozenset[str]
    pairs: tuple[tuple[float, ...], ...]

    def transition(self, text: str) -> float:
        at = [LETTERS.find(c) for c in text.lower()]
        got = [self.pairs[a][b] if a >= 0 and b >= 0 else -8.0 for a, b in zip(at[:-1], at[1:], strict=True)]
        return sum(got) / len(got) if got else 0.0

    def coverage(self, text: str) -> float:
        """Share of the characters in dictionary words, longest first from the left."""
        low, i, covered = text.lower(), 0, 0
        while i < len(low):
            n = next((n for n in range(min(12, len(low) - i), 2, -1) if low[i : i + n] in self.words), 0)
            covered += n
            i += n or 1
        return covered / max(1, len(low))


def learn_language(docs: DataFrame, share: float = SHARE) -> Language:
    """The words of 3 to 12 letters in at least ``share`` of the documents, and the letter pairs of all such words.

    A word counts once for each document that holds it. Their number is bounded by the
    distinct words of a mean document over ``share``, at every size of the table.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-zß-öø-ÿ]+"))).alias("word")).filter("length(word) between 3 and 12")
    counts = durable(words.groupBy("word").count())
    top = counts.filter(F.col("count") >= share * docs.count()).select("word").collect()
    pairs = np.ones((26, 26))
    at = F.sequence(F.lit(1), F.length("word") - 1)
    cut = counts.select(F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(2)))).alias("pair"), "count")
    for pair, n in cut.filter(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("count")).collect():
        pairs[LETTERS.index(pair[0]), LETTERS.index(pair[1])] += n
    logs = np.round(np.log(pairs / pairs.sum(axis=1, keepdims=True)), 6)
    return Language(frozenset(r["word"] for r in top), tuple(map(tuple, logs.tolist())))


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each private key block, of any length and with any headers.

    A block runs from its first to its last line. Where the next key line is a first line again, or there is none, the
    last line is missing: then the block ends with the lines that may be a key's body or its headers.
    """
    lines, out = list(KEY_LINE.finditer(text)), []
    for m, after in zip_longest(lines, lines[1:]):
        if m[1] == "BEGIN":
            whole = after is not None and after[1] == "END"
            stop = after.end() if whole else m.end() if m.end() < len(text) and text[m.end()] not in " \t\r\n" else KEY_BODY.match(text, m.end(), after.start() if after else len(text)).end()
            out.append((m.start(), stop if whole else m.start() + len(text[m.start() : stop].rstrip())))
    return out


class Runs:
    """Where the values of unquoted assignments end.

    An unspaced run may hold many assignments. The first one's value is the whole rest of the run. The run is cut before
    the delimiters that stand before a name and a separator: of each piece the first assignment's value runs to the
    piece's end, any further one's to where the next begins. So the values of a run are three times its length at most.
    """

    def __init__(self, text: str):
        self.text, self.end = text, -1

    def _read(self, begin: int) -> None:
        m = SPACE.search(self.text, begin)
        self.end = m.start() if m else len(self.text)
        self.whole, self.seen, self.names = True, -1, []
        for m in WITHIN.finditer(self.text, begin, self.end):
            self.names.append((m.start(), m["cut"] is not None))
        self.at = 0

    def ends(self, begin: int) -> list[int]:
        """The ends of the value that begins here; values are asked for in ascending order."""
        if begin >= self.end:
            self._read(begin)
        while self.at < len(self.names) and self.names[self.at][0] < begin:
            self.at += 1
        # the next delimiter is looked for once for each piece
        if self.seen < self.at:
            self.seen = next((i for i in range(self.at, len(self.names)) if self.names[i][1]), len(self.names))
            first = True
        else:
            first = False
        piece = self.names[self.seen][0] if self.seen < len(self.names) else self.end
        near = self.names[self.at][0] if self.at < len(self.names) else self.end
        out = [piece if first else min(near, piece)]
        if self.whole:
            self.whole = False
            out.append(self.end)
        return [e for e in dict.fromkeys(out) if e > begin]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of each candidate, in order; one may lie inside another."""
    text = text or ""
    found = {m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0])}
    found.update(key_blocks(text))
    for m in FORMS.finditer(text):
        if m.lastgroup != "d" or any(c.isdigit() for c in m["d"]):
            found.add(m.span(m.lastgroup))
    runs = Runs(text)
    for m in SEPARATOR.finditer(text):
        before = text[max(0, m.start() - WINDOW) : m.start()]
        # the colons of an address, behind its scheme and before its password, assign nothing
        address = text.startswith("://", m.start()) or USER.search(before)
        if not address and NAME.search(before) and (value := VALUE.match(text, m.end())):
            if value.lastgroup == "d":
                begin = value.start("d")
                found.update((begin, end) for end in runs.ends(begin))
            else:
                found.add(value.span(value.lastgroup))
    return sorted(found)


def features(text: str, begin: int, end: int, path: str | None, language: Language) -> list[float]:
    value, before, after = text[begin:end], text[max(0, begin - WINDOW) : begin], text[end : end + WINDOW]
    n = len(value)
    share = lambda f: sum(map(f, value)) / n
    counts = Counter(value).values()
    name = ASSIGNED.search(before)
    near = before + " " + after
    return [
        float(n), share(str.isdigit), share(str.isupper), share(str.islower), share(lambda c: not c.isalnum()), len(counts) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), -sum(c / n * math.log2(c / n) for c in counts),
        language.transition(value), language.coverage(value), float(bool(PREFIXES.match(value))), float(bool(name)),
        float(bool(name and SECRET_NAMES.search(name[1]))), float(bool(name and HARMLESS_NAMES.match(name[1]))),
        float(before[-1:] in "\"'`" and bool(before)), float(bool(SECRET_NAMES.search(near))),
        float(any(HARMLESS_NAMES.match(w) for w in re.findall(r"\w+", near))), float(bool(TEST_PATHS.search(path or ""))),
        float(after[:1] == "@" and "://" in before), len(RUN.findall(value)) / n,
    ]


def _paths(docs: DataFrame, path: str | None):
    return (F.col(path) if path and path in docs.columns else F.lit(None)).cast("string")


def findings(docs: DataFrame, language: Language, path: str | None = "source") -> DataFrame:
    """(doc_id, begin, end, x array<double>) of every candidate."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _paths(docs, path).alias("path"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(doc, begin, end, features(text, begin, end, p, language)) for begin, end in candidates(text)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "begin", "end", "x"])
        release()

    return rows.mapInArrow(run, "doc_id long, begin int, end int, x array<double>")


def planted_findings(docs: DataFrame, language: Language, path: str | None = "source", hosts: int = HOSTS, least: int = PLANTED) -> DataFrame:
    """(label, x, held_out, found) of findings planted into at most ``hosts`` corpus texts, at least ``least`` in all.

    ``found`` tells whether the planted value is a candidate at all; where it is none, x is null.
    Only distinct texts are hosts, so a text with many copies is no more likely than another.
    """
    texts = docs.select(F.xxhash64("text").alias("k"), "text", _paths(docs, path).alias("path")).filter("text is not null")
    keys = texts.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(hosts).select(F.col("k").alias("chosen"))
    # at most ``hosts`` numbers; copies are merged before the shuffle
    held = texts.join(F.broadcast(keys), F.col("k") == F.col("chosen")).groupBy("k").agg(F.min(F.struct("text", "path")).alias("t"))
    chosen = durable(held.select("k", "t.text", "t.path"))
    n = chosen.count()
    each = -(-least // n) if n else 0

    def run(batches):
        for batch in batches:
            out = []
            for k, text, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = random.Random(k)
                for i in range(each):
                    # a stretch of the text is enough: features look at the words next to a finding
                    at = rng.randint(0, max(0, len(text) - 4 * WINDOW))
                    made, begin, end, label = plant(rng, text[at : at + 4 * WINDOW])
                    held = [s for s in candidates(made) if s[0] <= begin and end <= s[1] and s[1] - s[0] <= end - begin + 2]
                    span = min(held, key=lambda s: s[1] - s[0], default=None)
                    out.append((label, features(made, *span, p, language) if span else None, (k + i) % HOLD_OUT == 0, span is not None))
            kinds = [pa.int32(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "x", "held_out", "found"])

    return chosen.mapInArrow(run, "label int, x array<double>, held_out boolean, found boolean")


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, below, above) tuples with votes at the leaves; a single number votes for all."""

    trees: tuple

    def vote(self, x: list[float]) -> float:
        return sum(self._walk(t, x) for t in self.trees) / max(1, len(self.trees))

    @staticmethod
    def _walk(node, x: list[float]) -> float:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node


_SPLIT = re.compile(r"\s*If \(feature (\d+) <= ([-\d.Ee+]+)\)")


def _tree(lines: list[str]):
    """One tree of a forest's description."""
    line = lines.pop(0)
    if m := _SPLIT.match(line):
        below = _tree(lines)
        lines.pop(0)  # the Else line
        return int(m[1]), float(m[2]), below, _tree(lines)
    return float(line.split("Predict:")[1])


def sample(labelled: DataFrame, bound: int = FINDINGS) -> DataFrame:
    """(label, x, weight) of distinct findings; of each class the ``bound`` / 2 with the smallest hash.

    Copies count as a weight, 1 + log of their number, and take no place in the sample.
    """
    distinct = durable(labelled.groupBy("label", "x").agg((1 + F.log(F.count("*"))).alias("weight")))
    of = lambda c: distinct.filter(F.col("label") == c).orderBy(F.xxhash64("x"), "x").limit(bound // 2)
    return durable(of(0).union(of(1)))


def train(labelled: DataFrame, bound: int = FINDINGS) -> Forest:
    """A random forest from labelled findings (label, x)."""
    rows = sample(labelled.filter("label is not null and x is not null").select(F.col("label").cast("double"), "x"), bound)
    classes = [r[0] for r in rows.select("label").distinct().collect()]
    if len(classes) < 2:
        return Forest(tuple(classes))
    frame = rows.select("label", "weight", array_to_vector("x").alias("features"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2, weightCol="weight").fit(frame)
    return Forest(tuple(_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees))


def fit(docs: DataFrame, labels: DataFrame | None = None, path: str | None = "source") -> tuple[Language, Forest]:
    """The corpus's language, and a forest from a table of labelled findings or from planted ones."""
    language = learn_language(docs)
    if labels is not None:
        return language, train(findings(docs, language, path).join(labels.select("doc_id", "begin", "label"), ["doc_id", "begin"]))
    return language, train(planted_findings(docs, language, path).filter("not held_out"))


def held_out_quality(docs: DataFrame, language: Language, forest: Forest, path: str | None = "source") -> tuple[float, float]:
    """(recall, precision) on the planted findings that were held out; a secret that is no candidate is missed."""
    rows = planted_findings(docs, language, path).filter("held_out").select("label", "x").collect()
    kept = [(r["label"], r["x"] is not None and forest.vote(r["x"]) >= 0.5) for r in rows]
    hits = sum(label and k for label, k in kept)
    return hits / max(1, sum(label for label, _ in kept)), hits / max(1, sum(k for _, k in kept))


def secrets_in(text: str | None, path: str | None, language: Language, forest: Forest) -> tuple[int, list[tuple[int, int]]]:
    """Number of candidates, and the spans of those that the forest keeps; spans that overlap are one."""
    found, kept = candidates(text), []
    for b, e in found:
        if forest.vote(features(text or "", b, e, path, language)) >= 0.5:
            if kept and b < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(e, kept[-1][1]))
            else:
                kept.append((b, e))
    return len(found), kept


def scan(docs: DataFrame, language: Language, forest: Forest, path: str | None = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (``begin-end`` array) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _paths(docs, path).alias("path"))

    def run(batches):
        for batch in batches:
            got = [secrets_in(t, p, language, forest) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            spans = [[f"{b}-{e}" for b, e in s] for _, s in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.string()))],
                names=["doc_id", "n_candidates", "n_secrets", "spans"],
            )
        release()

    return rows.mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, spans array<string>")


def redact(docs: DataFrame, language: Language, forest: Forest, path: str | None = "source") -> DataFrame:
    """``docs`` with each secret replaced in ``text``; ``n_chars``, if there, follows the text."""
    at, lengths = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    at_path = docs.columns.index(path) if path and path in docs.columns else None

    def run(batches):
        for batch in batches:
            texts, paths = batch.column(at).to_pylist(), batch.column(at_path).to_pylist() if at_path is not None else [None] * batch.num_rows
            changed = {}
            for i, (text, p) in enumerate(zip(texts, paths, strict=True)):
                for begin, end in reversed(secrets_in(text, None if p is None else str(p), language, forest)[1]):
                    texts[i] = texts[i][:begin] + PLACEHOLDER + texts[i][end:]
                    changed[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if lengths is not None and changed:
                n = columns[lengths].to_pylist()
                columns[lengths] = pa.array([changed.get(i, v) for i, v in enumerate(n)], batch.schema.field(lengths).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        release()

    return docs.mapInArrow(run, docs.schema)
