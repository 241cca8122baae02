"""Readers and writers: tables, pages, index chunks, synonym sets, results."""
