"""skeinkg: knowledge-graph construction and text processing as plain DataFrame plans."""
