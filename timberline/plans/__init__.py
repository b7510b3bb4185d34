"""Driver-side compilation: patterns, schemas, automata and wildcard queries."""
