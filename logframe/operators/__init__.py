"""DataFrame operators over tables of lines."""
