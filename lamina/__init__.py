"""lamina: Spark jobs over large stacks of images, their spectra, and text corpora."""
