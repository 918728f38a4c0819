"""DataFrame operators over lines, words, lexicons, answers, readings and titles."""
