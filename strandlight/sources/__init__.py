"""Readers and writers: folder scans, probe answers, subtitle lines, manifests, keyed caches."""
