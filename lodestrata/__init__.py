"""Lodestrata: source trees and text corpora analysed as Spark DataFrames."""

__version__ = "0.1.0"
