"""chronotext: point-in-time panels and policy-text analytics as lazy Spark plans."""
