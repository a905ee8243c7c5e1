"""Independent DuckDB SQL for every registered query, in the direct form."""
