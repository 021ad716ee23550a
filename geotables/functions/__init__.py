"""SQL expression text built from built-in functions, so it stays inside Catalyst (pushdown, codegen) and runs on
executors."""
