"""A language-integrated SQL analytics engine on PySpark."""
