"""Training-data operators: scoring, deduplication, decontamination, line rules and token output.

Nothing else in the library imports this package. Operators read the columns `doc_id` and `text`
by name, so other columns, whatever their names, do no harm. Rows without a `doc_id` cannot be
referred to and are left out; a null text counts as empty; repeated rows are separate rows.
"""
