"""Readers and writers of alignments, traits, trees and traces."""
