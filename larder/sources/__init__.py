"""Readers of files and of payloads, each giving candidate records."""
