"""Readers and writers of sequence, hit and parameter files."""
