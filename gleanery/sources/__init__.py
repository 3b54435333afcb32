"""Readers and writers: web pages, crawl logs, judged corpora, vectors."""
