"""passagekit: a PySpark engine for building a passage corpus and retrieving
context for multiple-choice questions.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``); the heavy lifting stays in Catalyst/Tungsten, with Arrow
batches only for the vector kernels.
"""

__version__ = "0.1.0"
