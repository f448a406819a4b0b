"""meshwright: boundary-representation topology on Spark: references to geometry, curves, and topology rules."""
