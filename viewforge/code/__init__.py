"""Parsing, units and source-to-source edits of program text; plain Python that runs inside Arrow-backed functions."""
