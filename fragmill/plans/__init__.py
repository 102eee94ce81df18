"""Query plans: specifications, estimates, ordered steps, scripts."""
