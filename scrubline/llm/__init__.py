"""Training-data pipeline operators.

Thirteen operators: dedup, quality, language, archives, substring dedup, LM
scoring, decontamination, mixing, near-dedup, token output, filter audit,
vector codes, n-gram join.  Nothing else in the library imports this package;
``queries`` holds the registered ``opN_<name>`` queries with their SQL, each
defined in its operator's module.

Conventions shared by every operator:

* inputs are DataFrames; operators read only the columns they are told to use,
  so extra columns (also ones named like an operator's outputs) do no harm;
* a null text counts as an empty one; an empty table gives an empty result of
  the same schema;
* rows repeated word for word are separate rows: each gets its own result row.
"""
