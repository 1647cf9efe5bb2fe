"""DataFrame operators; columns inside a plan are named ``T.c``."""
