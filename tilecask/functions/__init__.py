"""Column functions: tile arithmetic, codes and names, fixed-point coordinates, codecs."""
