"""Volumetric imaging tables on Spark."""
