"""Pattern detection over file texts. Rules are data; one projection scans a text for all of them."""
