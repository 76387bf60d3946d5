"""Readers and writers for the file formats the engine takes in and gives out."""
