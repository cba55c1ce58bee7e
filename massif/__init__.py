"""massif: a PySpark-native engine for spectra, quantification matrices and sequences."""
