"""How much a plan may send to every executor."""

# Bytes, of a table whose size was measured. Dimensions are not marked at all: Spark
# broadcasts what it measures to be small and splits the hot keys of the joins it shuffles.
MAX_BROADCAST_BYTES = 128 * 1024 * 1024
