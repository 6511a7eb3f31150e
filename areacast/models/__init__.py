"""First-stage models: fitted on weighted cells, scored as Columns."""
