"""Operations on training corpora: cleaning, duplicates, leaks, languages, mixing, chat logs.

Nothing else in the library imports this subpackage.
"""
