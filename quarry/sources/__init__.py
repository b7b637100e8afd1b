"""Readers that turn folders of files into document tables."""
