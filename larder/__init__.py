"""larder: donation/claims analytics on Spark DataFrames.

Providers list surplus goods, receivers claim them.  The package cleans the
raw tables, audits keys and references, answers the catalogue of aggregate,
top-k, expiry and share questions, serves faceted and parameterised search,
and applies batches of inserts, updates and deletes with their referential
effects -- all as lazy DataFrame plans optimised by Catalyst.
"""

__version__ = "0.1.0"
