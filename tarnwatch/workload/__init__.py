"""The operators wired to concrete tables, each with an equivalent SQL text where there is one."""
