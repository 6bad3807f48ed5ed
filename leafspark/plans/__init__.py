"""Registered queries: the operators over the driver's tables, with equivalent SQL."""
