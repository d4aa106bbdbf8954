"""Column functions: URLs, text, tags, envelopes, pricing, model calls."""
