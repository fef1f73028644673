"""Operations for preparing training text. Nothing outside this package imports it."""
