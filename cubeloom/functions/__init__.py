"""Column expressions; none of them shuffles."""
