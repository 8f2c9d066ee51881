"""Column functions: ``Column`` in, ``Column`` out, stateless, usable in batch and streaming queries."""
