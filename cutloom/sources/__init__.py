"""Readers and writers of manifests, transcripts, cut lists and image sequences."""
