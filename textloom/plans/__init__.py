"""The named queries, their DuckDB SQL, and the session."""
