"""Column functions: URLs, scope patterns, image headers."""
