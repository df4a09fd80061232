"""Plans that the analyses share: legs of trades, position cubes, grids."""
