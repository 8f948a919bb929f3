"""Operators over long tables of alignments, traces, trees and statistics."""
