"""Building blocks shared by every operator."""
