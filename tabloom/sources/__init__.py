"""Readers, shape gates, the glossary table and sinks."""
