"""Readers, writers and the adapters from the test tables to the pipeline's inputs."""
