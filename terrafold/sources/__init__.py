"""Readers and writers of scans, labels, calibrations, poses and times."""
