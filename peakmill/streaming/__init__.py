"""No streaming operators: the reference reads finite files only."""
