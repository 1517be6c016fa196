"""Data kept between runs: facts laid out by month, states that take in new rows only, steps of a run."""
