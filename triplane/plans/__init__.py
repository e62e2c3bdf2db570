"""Query plans, their compiler, and the SPARQL front end."""
