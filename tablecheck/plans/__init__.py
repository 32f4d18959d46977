"""What a user runs: contracts, profiles, reports, scores, suggestions."""
