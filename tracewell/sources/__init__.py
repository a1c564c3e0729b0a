"""Table readers and writers: text formats in, tables and reports out."""
