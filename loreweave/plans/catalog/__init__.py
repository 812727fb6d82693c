"""One module per operator family; importing them fills the catalogue."""
