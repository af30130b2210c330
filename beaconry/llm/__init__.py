"""Training-data operators over documents, embeddings and benchmark tables.

Nothing outside this subpackage imports it.  Shared rules, unless an operator says otherwise:

* a null text counts as empty; a null id is kept as an ordinary value of its own row;
* only the columns an operator names are read, so extra columns (also ones named like its outputs) do no harm;
* repeated rows are separate rows, ties go to the smallest id, and an empty table gives an empty result.
"""
