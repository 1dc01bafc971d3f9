"""Plans: what external codecs and tools are to do, as columns that can be queried."""
