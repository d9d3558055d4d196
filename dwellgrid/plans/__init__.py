"""Questions: compositions of operators, one function per question."""
