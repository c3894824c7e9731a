"""Named queries over the test tables, and the SPARQL compiler."""
