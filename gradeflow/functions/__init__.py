"""Column expressions. Nothing here starts a job or needs Python workers."""
