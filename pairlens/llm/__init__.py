"""Training-data operators: one module per operator, plus shared helpers in ``common``."""
