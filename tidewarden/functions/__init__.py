"""Functions over DNS names, as Columns."""
