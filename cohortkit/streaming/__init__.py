"""Streaming scoring (stateless): new records -> cleaning -> saved pipeline -> sink."""
