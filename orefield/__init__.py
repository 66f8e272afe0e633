"""orefield: potential-field modelling and inversion as Spark relations."""
