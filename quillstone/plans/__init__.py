"""Record model, schema IR and exporters."""
