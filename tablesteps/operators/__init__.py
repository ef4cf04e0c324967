"""Row, column, grouping, validation and upsert steps (DataFrame -> DataFrame)."""
