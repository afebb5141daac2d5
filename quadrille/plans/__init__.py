"""Graph patterns over quads and over relational tables seen as graphs."""
