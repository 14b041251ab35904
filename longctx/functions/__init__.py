"""longctx."""
