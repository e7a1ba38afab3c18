"""Readers and writers: URL lists, crawl state, manifests, site configs, Markdown folders, node lists."""
