"""Reading a corpus and storing what an experiment produces."""
