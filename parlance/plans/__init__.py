"""Plans of whole datasets: which scenario gets which composition, scene, relation, voices and events."""
