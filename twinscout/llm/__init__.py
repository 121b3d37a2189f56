"""Operations of a training-data pipeline: one module per operator, ``queries`` holds the thin
registered queries.  Nothing outside this subpackage imports it."""
