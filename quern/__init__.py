"""quern: scoped, trust-labelled record storage, screening and hybrid retrieval as Spark plans."""

__version__ = "0.1.0"
