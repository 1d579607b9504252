"""Engine subpackage."""
