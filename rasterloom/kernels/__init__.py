"""Array kernels over one image: what ``rasterloom.operators.images`` runs on raster rows."""
