"""Training-data operators: de-duplication, formatting, filtering, mixing, packing.

Each module holds one operator with a general DataFrame interface; ``queries``
binds them to the driver's tables. Nothing else in the library imports this.
"""
