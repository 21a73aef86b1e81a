"""Knowledge providers that ask a language model over a transport given by the caller."""
