"""Column functions: text in, column out; nothing here runs Python on executors."""
