"""Training-data operators: deduplication, decontamination, classifiers,
personal data, licence scans, HTML extraction and tokenisation.

Nothing else in the library imports this subpackage.
"""
