"""Query catalogues: what each named query runs and the SQL it must agree with."""
