"""Column expressions: marker kinds, natural order, presentation, polynomial fits."""
