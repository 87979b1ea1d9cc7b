"""Part of Lumetra."""
