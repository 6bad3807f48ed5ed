"""Column functions: plain expressions that Catalyst sees through."""
