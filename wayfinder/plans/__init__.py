"""Plans, the policy that chooses access paths, and the front ends."""
